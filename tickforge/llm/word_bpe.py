"""BPE encoding and decoding by speculation and verification.

A text is cut into words. For words not seen yet, all at once:

1. *Speculate*: a greedy longest match walks a trie of the vocabulary for all
   words of the batch in step (numpy).
2. *Verify*: a token sequence is what the merges yield if and only if every
   adjacent pair is, that is if merging the symbols of the two tokens alone
   gives back the two (and a lone token if merging its symbols gives it back).
   All pairs of the batch are looked up in a table of verdicts; pairs not in
   the table are merged once.
3. *Repair*: only words with a failing pair are merged exactly.

Built for vocabulary files of the kind that lower-cases, drops white space and
marks the end of a word with a suffix; everything is read from the file.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import fresh, slices, worker_state

#: Bytes of words and their ids that a Python worker remembers, twice over: those used since the last change and those before.
MEMORY_WORDS = 32 << 20
#: The same of chunks of texts that are not Latin.
MEMORY_CHUNKS = 12 << 20
#: Bytes that a remembered string takes besides its own: two objects and a place in a table.
MEMORY_ENTRY = 180
#: Pair verdicts that a worker remembers.
MEMORY_PAIRS = 1_000_000
#: Characters of text that are split and encoded at once.
STEP_CHARS = 1 << 20
END = 1  # low bit of a symbol: last of its word
NO_MERGE = 1 << 60
#: Symbols from which merging uses a heap.
LONG_WORD = 64

_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Texts that need no library: composed Latin letters are in normal form C (but for U+0130 they have one lower-case letter).
_LATIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u017e]*")
#: Python's split() also cuts at these, the vocabulary's pattern does not.
_CONTROL = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memory:
    """Ids of strings, bounded in bytes: when the new half is full the old half goes.

    What is used stays: a string that is asked for moves to the new half.
    """

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def missing(self, wanted) -> list:
        """Those of ``wanted`` (distinct) that are not remembered; the others are in ``new`` from here on."""
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        old, unknown = self.old, []
        for x in set(wanted).difference(self.new):
            ids = old.get(x)
            if ids is None:
                unknown.append(x)
            else:
                self.add(x, ids)
        return unknown

    def add(self, key: str | int, ids: bytes) -> None:
        self.new[key] = ids
        self.size += len(ids) + MEMORY_ENTRY + (len(key) if isinstance(key, str) else 0)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.names = np.full(max(self.tokens) + 1, "", object)
        for i, t in self.tokens.items():
            self.names[i] = t
        self.decimals = np.array([str(i) for i in range(len(self.names))], object)
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for kind in "LN":  # the classes inside Latin texts
            pattern = pattern.replace(f"\\p{{{kind}}}", "".join(
                chr(c) for c in range(0x21, 0x17F) if unicodedata.category(chr(c))[0] == kind))
        self.word_re = re.compile(pattern)
        self.path = path
        self.letters = letters = _byte_letters()
        self.base = np.zeros(512, np.int64)  # symbol (byte * 2 + END) -> id
        for letter, byte in letters.items():
            self.base[2 * byte] = vocab[letter]
            self.base[2 * byte + END] = vocab[letter + suffix]
        self.merges: dict[int, int] = {}  # left << 20 | right -> rank << 20 | merged
        symbols: dict[int, tuple[int, ...]] = {int(i): (s,) for s, i in enumerate(self.base)}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault(left << 20 | right, rank << 20 | made)
            if left in symbols and right in symbols:
                symbols.setdefault(made, symbols[left] + symbols[right])
        self.symbols = symbols
        self._trie(symbols)
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.merge_keys = keys[order]
        self.merge_to = np.fromiter(self.merges.values(), np.int64, len(self.merges))[order]
        self.chunks, self.words = Memory(MEMORY_CHUNKS), Memory(MEMORY_WORDS)

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The vocabulary's own library, read when first needed."""
        return Tokenizer.from_file(self.path)

    def _trie(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """Edges (state * 512 + symbol) -> state, sorted; the token that ends in each state or -1."""
        edges: dict[int, int] = {}
        token = [-1]
        for t, word in symbols.items():
            state = 0
            for s in word:
                nxt = edges.get(state * 512 + s)
                if nxt is None:
                    nxt = edges[state * 512 + s] = len(token)
                    token.append(-1)
                state = nxt
            token[state] = t
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.state_token = np.array(token, np.int64)

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals. Changes ``ids``."""
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) != NO_MERGE:
            i = ranks.index(low)
            ids[i:i + 2] = [low & 0xFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NO_MERGE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words where scanning all ranks each time is too slow."""
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NO_MERGE)) != NO_MERGE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    r = get(ids[left] << 20 | ids[right], NO_MERGE)
                    if r != NO_MERGE:
                        heapq.heappush(heap, (r, left))
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged of pairs of ids, NO_MERGE where nothing merges (or an id is -1)."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_to[at], NO_MERGE)

    def merge_all(self, ids: np.ndarray) -> list[bytes]:
        """Exact merging of many words in step; rows of ids, padded by -1 at the end (one column of it at least)."""
        out: list[bytes] = [b""] * len(ids)
        word, ranks = np.arange(len(ids)), self._rank(ids[:, :-1], ids[:, 1:])
        while len(word):
            at = ranks.argmin(1)
            low = ranks[np.arange(len(word)), at]
            done = low == NO_MERGE
            if done.any():
                size = (ids[done] >= 0).sum(1).tolist()
                for w, row, n in zip(word[done].tolist(), ids[done].astype("<u4"), size, strict=True):
                    out[w] = row[:n].tobytes()
                word, ids, ranks, at, low = (x[~done] for x in (word, ids, ranks, at, low))
                if not len(word):
                    break
            here = np.arange(len(word))
            ids[here, at] = low & 0xFFFFF
            place = np.arange(ids.shape[1] - 1)[None]
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
            place = place[:, :-1]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), 1)
            right = at < ranks.shape[1]
            i, j = here[right], at[right]
            ranks[i, j] = self._rank(ids[i, j], ids[i, j + 1])
            i, j = here[at > 0], at[at > 0]
            ranks[i, j - 1] = self._rank(ids[i, j - 1], ids[i, j])
        return out

    def merge_flat(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Exact merging of the words sym[start:end]: in step by groups of length, one by one if long."""
        size, ids, out, low = end - start, self.base[sym], [b""] * len(start), 0
        for width in (8, 16, 32, LONG_WORD):
            part = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(part):
                place = start[part][:, None] + np.arange(width + 1)
                inside = place < end[part][:, None]
                rows = np.where(inside, ids[np.where(inside, place, 0)], -1)
                for i, x in zip(part.tolist(), self.merge_all(rows), strict=True):
                    out[i] = x
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = np.array(self.merge(ids[start[i]:end[i]].tolist()), "<u4").tobytes()
        return out

    def merge_rows(self, rows: list) -> list[bytes]:
        """Exact merging of lists of symbols."""
        end = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        sym = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(end[-1]))
        return self.merge_flat(sym, np.concatenate([[0], end[:-1]]), end)

    def _speculate(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Greedy tokens of all words: (tokens, word of each), in order of word and place."""
        words, tokens, places = [], [], []
        word, at = np.arange(len(start)), start.copy()
        while len(word):
            state, here, live = np.zeros(len(word), np.int64), at.copy(), np.arange(len(word))
            token, stop = np.full(len(word), -1, np.int64), at.copy()
            while len(live):
                live = live[here[live] < end[word[live]]]
                key = state[live] * 512 + sym[here[live]]
                pos = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                live, pos = (x[self.edge_keys[pos] == key] for x in (live, pos))
                state[live] = self.edge_to[pos]
                here[live] += 1
                found = self.state_token[state[live]]
                hit = live[found >= 0]
                token[hit], stop[hit] = found[found >= 0], here[hit]
            words.append(word)
            tokens.append(token)
            places.append(at)
            more = stop < end[word]
            word, at = word[more], stop[more]
        w, t, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, tokens, places))
        order = np.argsort(p, kind="stable")
        return t[order], w[order]

    def _verdicts(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left << 20 | right; a lone token has left = -1) is stable."""
        want = np.unique(keys)
        if len(self.pair_keys) > MEMORY_PAIRS:
            self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        new = want[~np.isin(want, self.pair_keys, assume_unique=True)]
        if len(new):
            pairs = [[k & 0xFFFFF] if k < 0 else [k >> 20, k & 0xFFFFF] for k in new.tolist()]
            merged = self.merge_rows([[s for t in pair for s in self.symbols[t]] for pair in pairs])
            ok = [x == np.array(pair, "<u4").tobytes() for x, pair in zip(merged, pairs, strict=True)]
            all_keys = np.concatenate([self.pair_keys, new])
            order = np.argsort(all_keys)
            self.pair_ok = np.concatenate([self.pair_ok, np.array(ok, bool)])[order]
            self.pair_keys = all_keys[order]
        return self.pair_ok[np.searchsorted(self.pair_keys, keys)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32 bit) of each word (UTF-8 bytes of a piece, not empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(sizes)
        sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) * 2
        sym[end - 1] += END
        tokens, word = self._speculate(sym, end - sizes, end)
        left = np.empty_like(tokens)
        left[0], left[1:] = -1, tokens[:-1]
        first = np.ones(len(tokens), bool)
        first[1:] = word[1:] != word[:-1]
        count = np.bincount(word, minlength=len(words))
        lone = first & (count[word] == 1)
        test = lone | ~first
        keys = np.where(lone, (np.int64(-1) << 20) | tokens, left << 20 | tokens)[test]
        bad = np.zeros(len(words), bool)
        bad[word[test][~self._verdicts(keys)]] = True
        data, stop = tokens.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        out = [data[i:j] for i, j in zip([0, *stop], stop, strict=False)]
        fails = np.flatnonzero(bad)
        for i, x in zip(fails.tolist(), self.merge_flat(sym, (end - sizes)[fails], end[fails]), strict=True):
            out[i] = x
        return out

    def pieces(self, chunk: str) -> list[str]:
        """A chunk without white space and special tokens, normalised and cut into words.

        Beyond Latin letters, classes and cases differ between Unicode
        versions; there the vocabulary's own library normalises and cuts.
        """
        if _LATIN.fullmatch(chunk):
            return self.word_re.findall(chunk.lower())
        s = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.letters.__getitem__, p)).decode()
                for p, _ in self.library.pre_tokenizer.pre_tokenize_str(s)]

    def know(self, words) -> None:
        """Have the ids of all ``words`` in ``self.words.new``; those not remembered are encoded together."""
        unknown = self.words.missing(words)
        if unknown:
            for p, x in zip(unknown, self.encode_words([p.encode() for p in unknown]), strict=True):
                self.words.add(p, x)

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not remembered."""
        plan: list[list[str | int]] = []  # of each chunk: its words, or ids of special tokens
        for c in chunks:
            own = []
            for i, part in enumerate(self.special_re.split(c) if "<|" in c else [c]):
                own += [self.special[part]] if i % 2 else self.pieces(part) if part else []
            plan.append(own)
        self.know(p for own in plan for p in own if isinstance(p, str))
        words = self.words.new
        for c, own in zip(chunks, plan, strict=True):
            self.chunks.add(c, b"".join([words[p] if isinstance(p, str) else np.uint32(p).tobytes() for p in own]))

    def coded(self, texts: list[str]) -> list[bytes]:
        """The ids of every text (little-endian unsigned 32 bit); what is new in them is learnt together.

        A Latin text is cut into words at once, any other into chunks at white space.
        """
        latin = [bool(_LATIN.fullmatch(t)) and "<|" not in t for t in texts]
        cut = [self.word_re.findall(t.lower()) if plain else chunks_of(t) for t, plain in zip(texts, latin, strict=True)]
        unknown = self.chunks.missing(c for own, plain in zip(cut, latin, strict=True) if not plain for c in own)
        if unknown:
            self.learn(unknown)
        self.know(itertools.chain.from_iterable(own for own, plain in zip(cut, latin, strict=True) if plain))
        words, chunks = self.words.new.__getitem__, self.chunks.new.__getitem__
        return [b"".join(map(words if plain else chunks, own)) for own, plain in zip(cut, latin, strict=True)]

    def decode(self, ids) -> str:
        """The tokens of ``ids`` joined by blanks: the vocabulary names no decoder."""
        return " ".join(self.names[np.asarray(ids, np.int64)].tolist())

    def spell(self, ids) -> str:
        """``ids`` in decimal, joined by blanks."""
        return " ".join(self.decimals[np.asarray(ids, np.int64)].tolist())


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file, read once as long as no other operator works there."""
    return worker_state(f"codec {path}", lambda: Codec(path))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def chunks_of(text: str) -> list[str]:
    """Maximal runs without white space."""
    if _CONTROL.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def steps(texts: list[str]):
    """Lists of (text number, text) of about STEP_CHARS characters; a longer text comes in several parts, cut at white space."""
    part, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            cut = at + STEP_CHARS
            if cut < len(text):
                space = _SPACE.search(text, cut)
                cut = space.start() if space else len(text)
            else:
                cut = len(text)
            part.append((i, text[at:cut]))
            size += cut - at
            at = max(cut, 1)
            if size >= STEP_CHARS:
                yield part
                part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, keep: list[str] | None = None,
           ids: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns the columns ``keep`` (all of ``docs`` unless given) and n_tokens,
    ids_sha256, decoded_sha256 and, with ``ids``, the ids (array of int) and
    the decoded text; names that ``docs`` has already are prefixed by
    underscores. Null text counts as empty and has no tokens; repeated rows
    are each encoded; rows are independent, so nothing is shuffled.
    """
    path = vocabulary or default_vocabulary()
    keep = docs.columns if keep is None else keep
    (body,) = fresh(docs, "_body")
    names = fresh(docs.select(*keep), "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    names = names if ids else names[:3]
    types = ["bigint", "string", "string", "array<int>", "string"]
    src = docs.select(*keep, docs[text].alias(body))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + [f"`{n}` {t}" for n, t in zip(names, types, strict=False)])

    def run(batches):
        bpe = codec(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = [0] * len(texts)
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            whole = [([], []) for _ in texts] if ids else None
            for part in steps(texts):
                for (i, _), coded in zip(part, bpe.coded([c for _, c in part]), strict=True):
                    if not coded:
                        continue
                    own = np.frombuffer(coded, "<u4")
                    spelt = (bpe.spell(own), bpe.decode(own))
                    gap = " " if counts[i] else ""
                    counts[i] += len(own)
                    for digest, s in zip(sums[i], spelt, strict=True):
                        digest.update((gap + s).encode())
                    if whole:
                        whole[i][0].append(own)
                        whole[i][1].append(spelt[1])
            out = [*batch.columns[:-1], pa.array(counts, pa.int64()),
                   *[pa.array([s[k].hexdigest() for s in sums], pa.string()) for k in (0, 1)]]
            if whole:
                out.append(pa.array([np.concatenate([*w[0], np.zeros(0, "<u4")]).astype(np.int32) for w in whole],
                                    pa.list_(pa.int32())))
                out.append(pa.array([" ".join(w[1]) for w in whole], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *names])

    return src.mapInArrow(run, schema)
